"""loomgraph: a knowledge-graph retrieval engine made of Spark DataFrames."""
