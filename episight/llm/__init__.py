"""Operators for preparing training data: licence scans, language-model
scores, quality rules, archives, near-duplicates, tokenisation, mixing, media
sequences and sharding.  Nothing outside this subpackage imports it."""
