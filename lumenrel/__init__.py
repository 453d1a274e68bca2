"""A Spark-native relational engine with ordered lists, bags, options and fix-points."""
