"""Training-data operators: language ID, fingerprints, near-duplicate removal,
packing, tokenization, archive audits, chat formatting and page extraction.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries
only when it is present."""
