"""Schemas of the tables that the engine reads and returns."""

DETECTION = "video_id string, frame_idx int, pts_s double, candidates array<struct<cx: double, cy: double, w: double, h: double, conf: double>>"
TRAJECTORY = "idx int, t_s double, y_m double, v_mps double, det_h_px double, det_conf double"
REP = "start_idx long, end_idx long, start_time double, end_time double, duration_s double, rom_m double, mcv_mps double, pcv_mps double"
REP_JSON = "start_idx: string, end_idx: string, start_time: string, end_time: string, duration_s: string, rom_m: string, mcv_mps: string, pcv_mps: string"
RESULT_JSON = f"video string, status string, fps string, mpp string, reps array<struct<{REP_JSON}>>"
INDEX = "video_id string, load_kg double, gt_reps_mcv array<double>, fps_override double, session_id int, hold_out boolean, failure_class string, failure_subtype string, note string"
TRUTH = "filename string, load_kg double, " + ", ".join(f"rep{k} string" for k in range(1, 9))
REP_PAIRS = "rep_pairs array<struct<video: string, gt: double, pred: double, error: double>>"
STATUS = ("OK", "NO_PLATE_DETECTED", "NO_CLEAN_SEGMENT", "TOO_SHORT", "VIDEO_ERROR", "CALIBRATION_FAILED")
