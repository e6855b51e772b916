"""Declared schemas. Order is data, so every ordered relation carries an index."""

BLOCK = "doc_id string, block_idx int, style string, text string"
AI_MANIFEST = "id string, matches string, subject string, topic string, position string, generated_by string, vendor string, temperature double, prompt_template string, words_requested int, words_kept int, seed int"
EXTRA_SOURCE = "pdf string, route string, subject string, topic string, source_url string, date_evidence string"
OCR_PAIR = "source string, scan_idx int, ocr string, clean string, similarity double"
