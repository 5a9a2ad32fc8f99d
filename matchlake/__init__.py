"""matchlake: DataFrame functions for catalogs of competitive match records."""
