"""Operations of a training-data pipeline: scoring, near-duplicate removal, search, token counts, packing."""
