"""siltstone: a PySpark-native retrieval and analytics engine for transcripts, notes and documents."""
