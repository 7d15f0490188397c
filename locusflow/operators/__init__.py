"""Statistics, filters, linkage, distances and ordination over VariantFrames."""
