"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, html, linededup, mixing, neardup, pitmanyor, quality, simhash, toxicity, warc

QUERIES = {
    "op1_main_text": html.query,
    "op2_decontamination": decontaminate.query,
    "op3_mixing": mixing.query,
    "op4_toxicity": toxicity.query,
    "op5_quality": quality.query,
    "op6_line_dedup": linededup.query,
    "op7_pitman_yor": pitmanyor.query,
    "op8_embedding_neardup": neardup.query,
    "op9_simhash": simhash.query,
    "op10_warc": warc.query,
}
SQL = {"op3_mixing": mixing.SQL, "op6_line_dedup": linededup.SQL, "op8_embedding_neardup": neardup.SQL, "op10_warc": warc.SQL}
