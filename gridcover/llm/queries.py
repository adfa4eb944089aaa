"""The queries of this part, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, jaccard, jpeg, language, mixing, quality, tokens, toxicity, url_filter, warc


def queries() -> dict:
    return {
        "op1_warc_revisits": warc.op1_warc_revisits,
        "op2_mixing": mixing.op2_mixing,
        "op3_token_counts": tokens.op3_token_counts,
        "op4_quality": quality.op4_quality,
        "op5_jaccard": jaccard.op5_jaccard,
        "op6_language": language.op6_language,
        "op7_media": jpeg.op7_media,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_url_filter": url_filter.op10_url_filter,
    }


def oracle_sql() -> dict:
    return {
        "op1_warc_revisits": warc.OP1_SQL,
        "op2_mixing": mixing.OP2_SQL,
        "op5_jaccard": jaccard.OP5_SQL,
        "op8_decontaminate": decontaminate.OP8_SQL,
        "op10_url_filter": url_filter.OP10_SQL,
    }
