"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores. Every query is run to completion into a sink
that discards rows, once, after a warm-up that runs the first of them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from footlamp import get_session  # noqa: E402
from footlamp.catalog import REGISTRY  # noqa: E402

HEADLINE = [
    "pln5_plan_enhancement", "frm6_structure_features", "frm9_lighting_class", "frm13_scene_vote", "frm17_flicker",
    "frm18_psnr", "frm19_ssim", "frm22_background_model", "frm24_motion_mask_multi", "frm31_mask_regions",
    "frm33_bilateral_level1", "frm36_resample_cubic_x4", "frm36_resample_lanczos4_x2", "til3_assemble_tiles",
    "aud1_signal_stats", "aud6_stereo_features", "aud7_stft", "aud11_spectral_descriptors", "aud23_audio_quality",
    "aud24_loudness_normalise", "aud26_compress_envelope", "aud27_spectral_gate", "aud36_sync_offset",
    "val2_frame_gaps", "val8_playback_score", "val14_validate_config", "pln3_plan_adaptive", "pln14_score_hosts",
    "jon1_pending_segments", "jon3_classify_errors", "jon6_restore_point", "jon7_session_pairs", "jon8_segments_to_timeline",
    "agg3_progress", "agg7_batch_report", "agg12_recovery_metrics", "agg15_folder_sizes",
    "win4_bottleneck_last_n", "win6_adaptive_multiplier", "win7_utilisation_stats", "top2_merge_order",
    "str3_stream_resource_tumbling", "str4_stream_bottlenecks",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().write.format("noop").mode("overwrite").save()
    REGISTRY[HEADLINE[0]].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
