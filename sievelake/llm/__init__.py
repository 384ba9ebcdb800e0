"""Training-data operators: dedup, quality, language, secrets, mixing, sharding, decontamination.

Nothing outside this folder imports it (``__spark_entry__`` adds its queries only where it is present).
"""
