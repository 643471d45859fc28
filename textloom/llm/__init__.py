"""Operations for preparing training data: deduplication, filters, archives, sharding, mixing and packing."""
