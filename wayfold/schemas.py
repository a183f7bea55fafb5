"""Canonical tables: Spark schemas, primary keys, canonical orders, and fixed vocabularies.

Spark reads every Parquet field as nullable, so `violations` re-checks nullability, finiteness and keys on the data.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed vocabularies, in rank order.
AGENT_CLASSES = ("vehicle", "pedestrian", "cyclist", "other_dynamic", "unknown")
ORIGIN_TYPES = ("source_ground_truth", "source_observation", "synthetic", "oracle_converted", "inferred", "decoded", "edited", "derived_metric")
PRIMITIVES = ("hold", "linear", "cubic_hermite")
EVENT_TYPES = ("stop", "left_turn", "right_turn", "acceleration", "braking", "gap")
WAYPOINT_ROLES = (
    "track_start", "track_end", "run_start", "run_end", "gap_start", "gap_end", "stop_start", "stop_end", "turn_entry",
    "turn_apex", "turn_exit", "acceleration_start", "acceleration_end", "braking_start", "braking_end",
)
CATEGORIES = ("stationary", "straight", "left_turn", "right_turn", "stop_and_go", "accelerating", "braking", "mixed", "gap_affected")
MAP_ELEMENTS = ("lane_centerline", "lane_boundary", "road_area", "crosswalk", "walkway", "junction_area", "access_zone", "other")
GEOMETRIES = ("point", "linestring", "polygon", "multilinestring", "multipolygon")
DIRECTIONS = ("directed", "bidirectional", "unknown", "not_applicable")
EXCLUSION_REASONS = (
    "adapter_failure", "invalid_timestamps", "insufficient_samples", "insufficient_duration", "unsupported_agent_class", "no_usable_map",
    "insufficient_trajectory_coverage", "coordinate_frame_mismatch", "duplicate", "geographic_leakage_conflict", "invalid_geometry",
    "resource_limit_exclusion", "other_documented_reason",
)
SPLITS = ("smoke", "development", "pilot", "test", "held_out_city")

#: Columns of the canonical tables (fixed values): name:type, "?" marks nullable ones, "[]" lists.
_COLUMNS = {
    "scenario_manifest": "scenario_id:string dataset_id:string dataset_version:string split_name:string city_or_region:string? source_scenario_id:string? start_time_ns:long end_time_ns:long coordinate_frame_id:string origin_x_m:double origin_y_m:double origin_z_m:double? source_crs:string? has_elevation:boolean agent_count:int source_map_available:boolean quality_flags:string[] adapter_name:string adapter_version:string source_checksum:string?",
    "coordinate_frame_metadata": "scenario_id:string coordinate_frame_id:string parent_frame_id:string? frame_type:string origin_x_m:double origin_y_m:double origin_z_m:double? axis_convention:string distance_unit:string angle_unit:string timestamp_unit:string source_crs:string? has_elevation:boolean transform_to_parent_4x4:double[]? origin_type:string quality_flags:string[]",
    "agent_metadata": "scenario_id:string agent_id:string source_agent_id:string? agent_class:string length_m:float? width_m:float? height_m:float? first_time_ns:long last_time_ns:long sample_count:int is_focal_agent:boolean is_ego_agent:boolean origin_type:string quality_flags:string[]",
    "trajectory_samples": "scenario_id:string agent_id:string trajectory_id:string sample_index:int timestamp_ns:long x_m:double y_m:double z_m:double? heading_rad:double? velocity_x_mps:double? velocity_y_mps:double? speed_mps:double? acceleration_x_mps2:double? acceleration_y_mps2:double? is_observed:boolean is_valid:boolean origin_type:string quality_flags:string[]",
    "vector_map_elements": "scenario_id:string map_element_id:string element_type:string geometry_type:string geometry_wkb:binary directionality:string parent_element_id:string? successor_ids:string[] predecessor_ids:string[] left_neighbor_id:string? right_neighbor_id:string? semantic_attributes_json:string? origin_type:string quality_flags:string[]",
    "procedural_tape_manifest": "tape_id:string scenario_id:string coordinate_frame_id:string source_dataset_id:string source_dataset_version:string source_validation_report_identity:string? encoder_name:string encoder_version:string encoder_parameters_identity:string start_time_ns:long end_time_ns:long track_count:int segment_count:int source_sample_count:long encoded_valid_sample_count:long has_elevation:boolean origin_type:string quality_flags:string[]",
    "procedural_tracks": "tape_id:string scenario_id:string procedural_track_id:string agent_id:string trajectory_id:string agent_class:string start_time_ns:long end_time_ns:long source_sample_count:int valid_sample_count:int run_count:int segment_count:int has_elevation:boolean origin_type:string quality_flags:string[]",
    "procedural_segments": "tape_id:string procedural_track_id:string segment_id:string run_index:int segment_index:int primitive_type:string source_start_sample_index:int source_end_sample_index:int start_time_ns:long end_time_ns:long start_x_m:double start_y_m:double start_z_m:double? end_x_m:double end_y_m:double end_z_m:double? start_heading_rad:double? end_heading_rad:double? start_velocity_x_mps:double? start_velocity_y_mps:double? end_velocity_x_mps:double? end_velocity_y_mps:double? parameter_values:double[] origin_type:string quality_flags:string[]",
    "semantic_waypoints": "tape_id:string procedural_track_id:string waypoint_id:string waypoint_index:int waypoint_role:string timestamp_ns:long source_sample_index:int? x_m:double y_m:double z_m:double? heading_rad:double? speed_mps:double? related_event_ids:string[] origin_type:string quality_flags:string[]",
    "motion_events": "tape_id:string procedural_track_id:string event_id:string event_index:int event_type:string start_waypoint_id:string anchor_waypoint_id:string end_waypoint_id:string start_time_ns:long anchor_time_ns:long end_time_ns:long magnitude_value:double? semantic_attributes_json:string origin_type:string quality_flags:string[]",
    "motion_categories": "category_id:string category_label:string agent_class:string event_signature_json:string representative_template_id:string template_count:int track_count:int origin_type:string quality_flags:string[]",
    "route_templates": "template_id:string category_id:string scenario_id:string coordinate_frame_id:string representative_track_id:string member_count:int geometry_type:string geometry_wkb:binary path_length_m:double duration_ns:long event_signature_json:string semantic_attributes_json:string origin_type:string quality_flags:string[]",
    "route_template_memberships": "template_id:string procedural_track_id:string membership_index:int scenario_id:string agent_id:string trajectory_id:string mean_path_error_m:double maximum_path_error_m:double start_distance_m:double end_distance_m:double path_length_ratio:double duration_ratio:double map_route_signature_json:string? origin_type:string quality_flags:string[]",
}
_KEYS = {
    "scenario_manifest": ("scenario_id", "scenario_id"),
    "coordinate_frame_metadata": ("scenario_id coordinate_frame_id", "scenario_id coordinate_frame_id"),
    "agent_metadata": ("scenario_id agent_id", "scenario_id agent_id"),
    "trajectory_samples": ("scenario_id trajectory_id sample_index", "scenario_id trajectory_id timestamp_ns"),
    "vector_map_elements": ("scenario_id map_element_id", "scenario_id element_type map_element_id"),
    "procedural_tape_manifest": ("tape_id", "scenario_id tape_id"),
    "procedural_tracks": ("tape_id procedural_track_id", "scenario_id tape_id"),
    "procedural_segments": ("tape_id procedural_track_id run_index segment_index",) * 2,
    "semantic_waypoints": ("tape_id procedural_track_id waypoint_id", "tape_id procedural_track_id waypoint_index waypoint_id"),
    "motion_events": ("tape_id procedural_track_id event_id", "tape_id procedural_track_id event_index event_id"),
    "motion_categories": ("category_id", "category_label agent_class category_id"),
    "route_templates": ("template_id", "scenario_id category_id template_id"),
    "route_template_memberships": ("template_id procedural_track_id", "template_id membership_index procedural_track_id"),
}
_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    key: tuple[str, ...]
    order: tuple[str, ...]

    def fingerprint(self) -> str:
        """Digest of the schema, for manifests."""
        return hashlib.sha256(f"wayfold:table:v1\n{json.dumps([self.schema.jsonValue(), self.key, self.order], sort_keys=True)}".encode()).hexdigest()


def _field(text: str) -> T.StructField:
    name, kind = text.split(":")
    nullable, kind = kind.endswith("?"), kind.rstrip("?")
    base = T.ArrayType(_TYPES[kind[:-2]]) if kind.endswith("[]") else _TYPES[kind]
    return T.StructField(name, base, nullable)


TABLES = {name: TableSpec(name, T.StructType([_field(c) for c in columns.split()]), tuple(_KEYS[name][0].split()), tuple(_KEYS[name][1].split())) for name, columns in _COLUMNS.items()}


def assert_schema(df: DataFrame, spec: TableSpec) -> None:
    """Names, order and types must be the table's exactly."""
    have, want = [(f.name, f.dataType.simpleString()) for f in df.schema], [(f.name, f.dataType.simpleString()) for f in spec.schema]
    if have != want:
        raise ValueError(f"{spec.name}: expected {want}, found {have}")


def row_problems(spec: TableSpec) -> Column:
    """Array of what is wrong with a row: nulls where none may be, numbers that aren't finite, blank strings."""
    checks = []
    for f in spec.schema:
        c = F.col(f.name)
        if not f.nullable:
            checks.append(F.when(c.isNull(), F.lit(f"{f.name}:null")))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            checks.append(F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(f"{f.name}:not_finite")))
        if isinstance(f.dataType, T.StringType):
            checks.append(F.when(F.trim(c) == "", F.lit(f"{f.name}:blank")))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def violations(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(key columns, problem): every broken row or key rule of a canonical table."""
    keys = [F.col(k).cast("string").alias(k) for k in spec.key]
    rows = df.select(*keys, F.explode(row_problems(spec)).alias("problem"))
    repeated = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*spec.key, F.lit("key:repeated").alias("problem"))
    return rows.unionByName(repeated)


def rank_of(column: Column, vocabulary: tuple[str, ...]) -> Column:
    """Place of a value in its vocabulary, from 0; for tie-breaks."""
    return F.array_position(F.array(*map(F.lit, vocabulary)), column).cast("int") - 1
