"""Queries of the training-data operators and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bpe, chat, hnsw, importance, line_dedup, minhash, mixing, mjpeg, periodic, quality, sharding, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_weighted_fair_mix": mixing.op1_weighted_fair_mix,
    "op2_perspective_rotation": chat.op2_perspective_rotation,
    "op3_avi_mjpeg_shots": mjpeg.op3_avi_mjpeg_shots,
    "op4_warc_index_ranges": warc.op4_warc_index_ranges,
    "op5_boosted_quality": quality.op5_boosted_quality,
    "op6_norm_bucket_topk": topk.op6_norm_bucket_topk,
    "op7_minhash_near_dedup": minhash.op7_minhash_near_dedup,
    "op8_forced_boundary_bpe": bpe.op8_forced_boundary_bpe,
    "op9_feistel_sharding": sharding.op9_feistel_sharding,
    "op10_line_template_dedup": line_dedup.op10_line_template_dedup,
    "op11_postings_resampling": importance.op11_postings_resampling,
    "op12_shard_graphs": hnsw.op12_shard_graphs,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op1_weighted_fair_mix": mixing.OP1_SQL,
    "op2_perspective_rotation": chat.OP2_SQL,
    "op4_warc_index_ranges": warc.OP4_SQL,
    "op6_norm_bucket_topk": topk.OP6_SQL,
    "op9_feistel_sharding": sharding.OP9_SQL,
    "op10_line_template_dedup": line_dedup.OP10_SQL,
    "op11_postings_resampling": importance.OP11_SQL,
}
