"""veldspar: a PySpark-native analytics engine for time series, graphs, vectors and bank risk."""
