"""The columnar file format: codec, reader, writer and Spark data source."""
