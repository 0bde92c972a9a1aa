"""lexspark: PySpark-native text analytics for corpus preparation and lexical analysis."""
