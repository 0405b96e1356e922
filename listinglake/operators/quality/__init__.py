"""Data-quality checks of a scraped batch and the gate they feed."""
