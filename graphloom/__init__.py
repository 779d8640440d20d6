"""PySpark-native analytics over scored knowledge graphs and the text around them."""
