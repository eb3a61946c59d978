"""The queries of this subpackage and the SQL they are held against."""

from plinth.llm import bpe, langid, licences, line_dedup, mixing, neighbours, quality, sentence_pieces, simhash, spellings, token_files, url_filter, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_simhash": simhash.query,
    "op3_source_mixing": mixing.query,
    "op4_token_files": token_files.query,
    "op5_neighbours": neighbours.query,
    "op6_licence_scan": licences.query,
    "op7_language_id": langid.query,
    "op8_url_filter": url_filter.query,
    "op9_bpe": bpe.query,
    "op10_quality_rules": quality.query,
    "op11_sentencepiece": sentence_pieces.query,
    "op12_whitening": whitening.query,
    "op13_spelling_variants": spellings.query,
}
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op3_source_mixing": mixing.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op10_quality_rules": quality.ORACLE,
    "op13_spelling_variants": spellings.ORACLE,
}
