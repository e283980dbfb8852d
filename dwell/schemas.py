"""Schemas of every table and file the engine reads or writes; none is inferred."""

from __future__ import annotations

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
LANDMARKS = "array<struct<x:float,y:float>>"

DETECTIONS = f"video_id string, frame_idx int, det_idx int, kind string, bbox {BOX}, score double, class_id int, landmarks {LANDMARKS}"
OBSERVATIONS = f"video_id string, frame_idx int, ts_ms double, track_id long, bbox {BOX}, score double"
SUBTRACKS = "track_id long, subtrack_id int, start_frame int, end_frame int, label string, frame_scores map<int,double>"
SEGMENTS = "byte_track_id long, subtrack_id int, label string, start_ms double, end_ms double, duration_ms double, frames int, avg_similarity double"
SAMPLE = (
    "path string, frame_idx int, ts_ms double, picked boolean, reason string, quality double, sharpness double, frontalness double, area_frac double, "
    "orientation string, score double, similarity_to_centroid double, provider string, association_iou double, match_mode string"
)
MANIFEST = f"track_id long, byte_track_id long, total_frames int, avg_conf double, avg_area double, first_ts_ms double, last_ts_ms double, samples array<struct<{', '.join(x.replace(' ', ':', 1) for x in SAMPLE.split(', '))}>>"
FACEBANK = "label string, count bigint, embedding array<float>"
FACEBANK_META = "labels array<string>, counts map<string,bigint>, num_labels int"
#: Numbers may be text, and files objects or plain destinations.
ASSIGNMENTS = "stem string, harvest_id string, byte_track_id string, person string, files array<string>, `when` string, app_version string, entry_id string"
CLUSTERS = "clusters array<struct<id:int,tracks:array<int>>>"
PROGRESS = "frames_total string, frames_done string, percent string, tracks string"
LOWCONF = "frame_idx int, track_id long, label string, score double"
ANNOTATIONS = "frame_annotations map<string,array<struct<track_id:bigint,bbox:array<double>,label:string,score:double>>>"
EVENT = "struct<track_id:bigint,bbox:array<double>,label:string,reason:string,score:double>"
#: Either one document with a map by frame, or a row a frame.
EVENTS = f"frame_events map<string,array<{EVENT}>>, frame_idx int, events array<{EVENT}>"
#: The annotations of a tracker run: a row a frame, or one document with a list of frames.
FRAMES = "frame_idx int, tracks array<struct<track_id:bigint,bbox:array<double>,label:string,score:double>>"
RUN = f"frame_annotations array<struct<{', '.join(x.replace(' ', ':', 1) for x in FRAMES.split(', '))}>>, {FRAMES}"
#: Fixed: the columns of the samples file, in its order.
SELECTED_COLUMNS = (
    "track_id byte_track_id frame quality sharpness frontalness area_frac picked reason path association_iou match_mode frame_offset identity_cosine similarity_to_centroid provider recall_only"
).split()
TOTALS = "label string, duration_ms double"
#: Fixed: the columns of the scene, candidate and cluster preview files.
SCENES = "scene_idx int, start_frame int, end_frame int"
CANDIDATES = "scene_idx int, frame_idx int, x1 int, y1 int, x2 int, y2 int, conf double, rel_path string"
PREVIEW = "cluster_id int, track_id long, scene_idx int, frame_idx int, rel_path string, cluster_rel_path string, cluster_path string, label string"
