"""Operations for building training data: filters, near duplicates, packing, archives and scores."""
