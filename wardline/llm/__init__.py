"""Training-data operators: fingerprints, language labelling, packing, language
model scoring, exact top-k, token files, near-duplicates, source mixing, web
archives and personal data.  Nothing else in the library imports this package."""
