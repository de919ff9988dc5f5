"""Training-data operators: filters, classifiers, de-duplication, PII, fingerprints, mixing."""
