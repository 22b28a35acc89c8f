"""Training-data operators: fingerprints, classifiers, mixing, sharding, dedup, decontamination, PII, licences."""
