"""pactframe: data contracts and training-data preparation as Spark DataFrame transformations."""
