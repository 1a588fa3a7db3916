"""Training-data operators: near-duplicate detection, quality rules,
SentencePiece segmentation, page rendering, URL rules, toxicity, packing,
exact search, secret scans, WARC archives, license scans, tokenizer alignment and
periodic runs. Nothing else in the library imports this subpackage."""
