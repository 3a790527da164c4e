"""Training-data preparation operators: filtering, linking, mixing and layout of large text tables."""
