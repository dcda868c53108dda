"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from lexmill.llm.decontam import OP6_SQL, op6_decontamination
from lexmill.llm.language_id import op7_language_id
from lexmill.llm.license_scan import OP13_SQL, op13_license_scan
from lexmill.llm.mpeg_audio import op8_mpeg_audio
from lexmill.llm.near_dedup import OP5_SQL, op5_near_dedup
from lexmill.llm.periodic_runs import OP11_SQL, op11_periodic_runs
from lexmill.llm.poisson_mix import OP10_SQL, op10_poisson_mix
from lexmill.llm.quality import op2_quality
from lexmill.llm.sharding import op4_sharding
from lexmill.llm.substring_dedup import op1_substring_dedup
from lexmill.llm.token_count import op9_token_counts
from lexmill.llm.vector_codes import OP12_SQL, op12_vector_codes
from lexmill.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality": op2_quality,
    "op3_warc": op3_warc,
    "op4_sharding": op4_sharding,
    "op5_near_dedup": op5_near_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_mpeg_audio": op8_mpeg_audio,
    "op9_token_counts": op9_token_counts,
    "op10_poisson_mix": op10_poisson_mix,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_license_scan": op13_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc": OP3_SQL,
    "op5_near_dedup": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op10_poisson_mix": OP10_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_license_scan": OP13_SQL,
}
