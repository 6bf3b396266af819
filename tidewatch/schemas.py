"""Explicit schemas of the domain tables."""

from __future__ import annotations

POSITIONS = (
    "mmsi string, ts timestamp, lat double, lon double, sog_ms double, cog_deg double, heading_deg double, name string, "
    "ship_type string, length_m double, width_m double, nav_status string, source string, is_ground_truth boolean"
)
SCENES = (
    "id string, collection string, acquisition_time timestamp, start_time timestamp, end_time timestamp, platform string, mode string, "
    "product_type string, polarizations array<string>, pass_direction string, relative_orbit int, absolute_orbit int, incidence_angle double, "
    "platform_heading_deg double, platform_speed_ms double, range_bearing_deg double, azimuth_bearing_deg double, "
    "footprint array<struct<lon:double,lat:double>>, granule_path string, item string, ingested_at timestamp"
)
RUNS = (
    "id string, scene_id string, detector string, version string, polarization string, started_at timestamp, seconds double, "
    "aoi_bbox array<double>, coastline string, parameters map<string,string>, statistics map<string,double>"
)
DETECTIONS = (
    "id string, run_id string, scene_id string, lon double, lat double, length_m double, width_m double, heading_deg double, confidence double, "
    "px_row double, px_col double, incidence_deg double, r_over_v_s double, cfar_margin_db double, created_at timestamp"
)
REFERENCE_DETECTIONS = "granule_id string, lon double, lat double, matched boolean"
DOCUMENTS = (
    "doc_id string, title string, text string, classification string, publisher string, doc_type string, language string, origin string, "
    "source_url string, licence string, date string, aoi array<string>"
)
CHUNKS = "doc_id string, chunk_id string, ordinal int, text string, heading string, char_start int, char_end int"
MANIFEST = "path string, bytes long, sha256 string, kind string, image string, role string, note string"
