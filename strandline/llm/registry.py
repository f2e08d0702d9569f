"""The numbered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, dialogue, language, language_model, lines, media, minhash, prefixes, quality, simhash, tiling, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_language": language.op2_language,
        "op3_warc": warc.op3_warc,
        "op4_media": media.op4_media,
        "op5_bpe": bpe.op5_bpe,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_line_dedup": lines.op7_line_dedup,
        "op8_language_model": language_model.op8_language_model,
        "op9_simhash": simhash.op9_simhash,
        "op10_decontaminate": tiling.op10_decontaminate,
        "op11_minhash": minhash.op11_minhash,
        "op12_repair": dialogue.op12_repair,
        "op13_prefixes": prefixes.op13_prefixes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.SQL, "op7_line_dedup": lines.SQL, "op11_minhash": minhash.SQL, "op12_repair": dialogue.SQL, "op13_prefixes": prefixes.SQL}
