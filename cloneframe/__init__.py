"""Spark-native analytics for immune repertoires: clones, distance joins, neighbourhoods."""
