"""Search strategies and ingestion plans composed from operators."""
