"""Fixed names. This module needs no session, so that Python workers can import it."""

from __future__ import annotations

KEYPOINTS = ("head", "tail", "mid", "ctr")
POSITIONS = [a + k for k in KEYPOINTS for a in "xy"]
BOX = ["xmin", "ymin", "xmax", "ymax"]
# Fixed column names of a raw track file and the names used here.
RAW_COLUMNS = {
    "X-Head": "xhead", "Y-Head": "yhead", "X-Tail": "xtail", "Y-Tail": "ytail",
    "X-Midpoint": "xmid", "Y-Midpoint": "ymid", "X-Centroid": "xctr", "Y-Centroid": "yctr",
    "Xmin-bbox": "xmin", "Ymin-bbox": "ymin", "Xmax-bbox": "xmax", "Ymax-bbox": "ymax",
}
STIMULUS_COLUMNS = ["stimulation", "Stim Ch1"]
