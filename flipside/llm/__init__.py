"""Training-data operators: classifiers, tokenizer codecs, deduplication, decontamination, binary and WARC files."""
