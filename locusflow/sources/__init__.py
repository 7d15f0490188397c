"""VCF text and the native Parquet layout."""
