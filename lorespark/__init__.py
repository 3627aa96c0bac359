"""Knowledge-base analytics on Spark: parse, chunk, embed, publish and search documents with DataFrames."""
