"""Operations of a training-data pipeline: dedup, packing, filtering, extraction, search, scoring and encoding."""
