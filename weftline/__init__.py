"""weftline: a Spark-native engine for labelled code- and text-interaction data."""
