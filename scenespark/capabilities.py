"""What can run here: optional libraries, asked for without importing them."""

from __future__ import annotations

import importlib.util
import shutil

from pyspark.sql import DataFrame, SparkSession

# fixed values: the stages that need more than this library, and what they need
NEEDS = {
    "video_decoding": ("cv2", None),
    "feature_extraction": ("cv2", None),
    "stereo_depth": ("cv2", None),
    "poisson_mesh": ("open3d", None),
    "external_sfm": (None, "colmap"),
    "learned_reconstruction": ("torch", None),
    "gaussian_training": ("gsplat", None),
    "completion_model": ("torch", None),
}


def capabilities() -> dict[str, dict]:
    """For each such stage whether it is available, and why not."""
    out = {}
    for stage, (module, program) in NEEDS.items():
        lost = f"module {module} is not installed" if module and not importlib.util.find_spec(module) else f"program {program} is not on the path" if program and not shutil.which(program) else None
        out[stage] = {"available": lost is None, "reason": lost}
    return out


def capability_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v["available"], v["reason"]) for k, v in capabilities().items()], "stage string, available boolean, reason string")


def require(stage: str) -> None:
    """An error with the reason if a stage cannot run here."""
    state = capabilities()[stage]
    if not state["available"]:
        raise RuntimeError(f"{stage}: {state['reason']}")
