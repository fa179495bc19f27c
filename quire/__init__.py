"""Document analytics on Spark: text, readings, page layout, page plans, assets, numbers and job events."""
