"""Closed schemas of the records, as DDL strings that readers and ``createDataFrame`` take."""

from __future__ import annotations

MASK = "struct<path:string,width:int,height:int,foreground_pixels:bigint,foreground_ratio:double,is_binary:boolean,unique_values:array<int>>"
BOX = "struct<x_min:int,y_min:int,x_max:int,y_max:int,width:int,height:int,x_min_normalized:double,y_min_normalized:double,x_max_normalized:double,y_max_normalized:double>"
CENTROID = "struct<x:double,y:double,x_normalized:double,y_normalized:double>"
MESSAGES = "array<struct<role:string,content:array<struct<type:string,image:string,text:string>>>>"
METADATA = "struct<source:string,category:string,condition:string,defect_type:string,location:string,visual_severity:string,answer_format:string,grounded_by:array<string>>"

CANONICAL_IMAGE = (
    "schema_version string, image_id string, source string, source_version string, category string, condition string, source_split string, defect_type string, image_path string, mask_path string, "
    f"annotation_path string, annotation_row int, width int, height int, file_size_bytes bigint, sha256 string, mask {MASK}"
)
DERIVED_IMAGE = f"{CANONICAL_IMAGE}, anomaly_area_pixels bigint, anomaly_area_ratio double, bounding_box {BOX}, centroid {CENTROID}, nine_grid_location string, visual_severity string, severity_basis string"
INSTRUCTION = f"schema_version string, instruction_id string, image_id string, dataset_split string, task_family string, template_id string, messages {MESSAGES}, metadata {METADATA}"
PREDICTION = (
    "schema_version string, run_id string, instruction_id string, image_id string, task_family string, category string, condition string, defect_type string, location string, visual_severity string, prompt string, "
    "ground_truth string, prediction string, input_token_count int, generated_token_count int, generation_time_seconds double, image_path string, generated_at_utc timestamp, error string"
)
