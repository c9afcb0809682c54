"""Training-data operators; each module stands alone and is imported on demand."""
