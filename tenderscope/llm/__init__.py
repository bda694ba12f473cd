"""Operations of a training-data pipeline: filters, searches, tokenizing, scoring, near-duplicates."""
