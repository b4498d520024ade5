"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from . import chat_formatting, decontamination, divergence, html_text, ngram_join, packing, pii, quality, toxicity, url_filters, warc, whitening, word_table

QUERIES = {
    f.__name__: f
    for f in (
        ngram_join.op1_ngram_join,
        html_text.op2_html_text,
        warc.op3_warc,
        pii.op4_pii,
        decontamination.op5_decontamination,
        quality.op6_quality,
        toxicity.op7_toxicity,
        url_filters.op8_url_filter,
        packing.op9_packing,
        chat_formatting.op10_chat_format,
        whitening.op11_whitening,
        divergence.op12_divergence,
        word_table.op13_bpe,
    )
}
ORACLES = {"op3_warc": warc.OP3_SQL, "op10_chat_format": chat_formatting.OP10_SQL, "op12_divergence": divergence.OP12_SQL}
