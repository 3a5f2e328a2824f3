"""lumenforge: image-authenticity and training-data analytics on PySpark."""
