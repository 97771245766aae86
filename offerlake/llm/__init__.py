"""Training-data operators; nothing outside this folder imports it but the driver entry and the corpus pipeline."""
