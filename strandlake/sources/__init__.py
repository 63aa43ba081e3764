"""Readers and writers: VCF text, side files, genetic maps, the panel store."""
