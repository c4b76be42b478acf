"""tidewright: a Spark-native engine for event ledgers, workflow state and ranked selection."""
