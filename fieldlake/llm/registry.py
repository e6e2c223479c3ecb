"""The subpackage's queries and their SQL."""

from fieldlake.llm import decontaminate, exact_dedup, html_text, licences, line_dedup, lm_score, near_dedup, quality, sentencepiece_codec, url_filter

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_html_text": html_text.op2_html_text,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
    "op5_licence_scan": licences.op5_licence_scan,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_quality": quality.op9_quality,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

SQL = {
    "op3_url_filter": url_filter.OP3_SQL,
    "op5_licence_scan": licences.OP5_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
