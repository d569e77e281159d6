"""folio: a Spark-native engine for triaging, organising and querying a document archive."""
