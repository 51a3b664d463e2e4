"""Training-data operators: fingerprints, decontamination, similarity join, token files,
packing, URL lists, language ID, licence scans, PII surrogates and language-model scores.

Nothing outside this package imports it.
"""
