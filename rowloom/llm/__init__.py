"""Training-data operators. Nothing outside this folder (and the pipeline module) imports it."""
